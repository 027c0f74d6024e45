"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text gives a likelihood for each language from hashed byte trigrams, counted over all labelled training documents.
Each row votes with the language that its text alone makes likeliest. Grouped counts of the votes give the chance of each
declared language and of each address suffix under a language, and priors of hosts, smoothed towards the prior of their
registered domain, which is smoothed towards that of all rows; a row's own vote is taken out of the counts that judge
it. A host that is its own domain is one level, not two, and so are rows without domains. The posterior multiplies the
four. A text whose trigrams no language makes likelier than chance is "und" (undetermined).

All counts are over all rows and all values. The counts of a row's values come by one join with the distinct combinations
of values; the rows are written with their text evidence before it, so that it is worked out once.

Contract for odd input: null and empty texts and texts without letters carry no text evidence: they cast no vote and
are "und" with posterior 0. A missing host or domain says nothing; a missing declared language or suffix counts as a value
of its own. Repeated rows vote as often as they occur. Without training rows every row is "und". The result
has the rows and columns of the input and one more, a struct named by a parameter; a column of that name is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from candlemill.llm.common import bound_batches, stage_table

BUCKET_BITS, SMOOTH = 13, 0.5
#: A text's trigrams aren't independent: it counts as at most so many independent ones. Strength of the smoothing of counts, hosts and domains.
MOST_TRIGRAMS, KAPPA, HOST_KAPPA = 60, 2.0, 5.0
UNDETERMINED, LEAST_POSTERIOR = "und", 0.5
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACES = re.compile(rb" +")


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, lower-cased, with all but letters as single spaces."""
    t = _SPACES.sub(b" ", text.translate(_FOLD)).strip()
    if not t:
        return np.zeros(1 << BUCKET_BITS, np.int64)
    b = np.frombuffer(b" " + t + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return np.bincount(h >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)


class TextModel:
    """Log probabilities of trigram buckets for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.table = np.log((counts + SMOOTH) / (total + SMOOTH * counts.shape[1])).T.copy() if languages else np.zeros((1 << BUCKET_BITS, 0))

    def evidence(self, text: bytes) -> list[float] | None:
        """Tempered log likelihood of each language relative to chance; None if the text gives none or is nothing known."""
        counts = trigram_counts(text)
        n = int(counts.sum())
        if not n or not self.languages:
            return None
        mean = counts @ self.table / n + BUCKET_BITS * np.log(2.0)
        return (mean * min(n, MOST_TRIGRAMS)).tolist() if mean.max() > 0 else None


def train(docs: DataFrame) -> TextModel:
    """From all rows of docs (text, lang) that have a language. Each task sends one row for each language and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[lang] = seen.get(lang, 0) + trigram_counts(text or b"")
        for lang, counts in seen.items():
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(counts[hit], pa.int64())], ["lang", "bucket", "n"])

    bound_batches(docs.sparkSession)
    rows = docs.where("lang is not null").select(F.col("text").cast("binary"), F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    for i, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        counts[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    return TextModel(languages, counts)


def markup_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments, navigation and tags."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(body, r"(?s)<[^>]*>", " ")


def declared_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"""(?is)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


#: Labels that are no registered domain below a country's suffix.
_GENERIC = ("ac", "co", "com", "edu", "gov", "net", "org")


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, or three where the last but one is a generic label below a country's suffix."""
    return F.regexp_extract(host, rf"([^.]+\.(?:(?:{'|'.join(_GENERIC)})\.[a-z][a-z]|[^.]+)|[^.]+)$", 1)


def identify(df: DataFrame, model: TextModel, *, text: Column, declared: Column, host: Column, suffix: Column, domain: Column, out: str = "language_id") -> DataFrame:
    """df with out: struct(language, posterior, votes: the languages' posteriors in the order of model.languages).

    host, suffix and domain may be empty or null, where rows have none.
    """
    spark = df.sparkSession
    bound_batches(spark)
    languages, k = model.languages, len(model.languages)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.evidence(t or b"") for t in texts], dtype=object)

    mark = uuid.uuid4().hex[:12]  # of columns that clash with none
    name = lambda x: f"__{x}_{mark}"
    clean = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kinds = {"declared": clean(declared), "suffix": clean(suffix), "host": clean(host), "domain": clean(domain)}
    kept = [c for c in df.columns if c != out]
    rows = df.withColumns({name(c): x for c, x in kinds.items()} | {name("text"): evidence(text.cast("binary"))})
    rows = stage_table(rows.select(*(F.col(f"`{c}`") for c in kept), *(name(c) for c in (*kinds, "text"))), "lid-rows")

    vote = (F.array_position(name("text"), F.array_max(name("text"))) - 1).cast("int")
    votes = rows.select(*(F.col(name(c)).alias(c) for c in kinds), vote.alias("v")).where("v is not null").groupBy(*kinds, "v").agg(F.count("*").alias("n"))
    votes = stage_table(votes, "lid-votes")
    each = F.array(*(F.coalesce(F.sum(F.when(F.col("v") == i, F.col("n"))), F.lit(0)).cast("double") for i in range(k))).cast("array<double>")
    overall = np.zeros(k)
    for r in votes.groupBy("v").agg(F.sum("n").alias("n")).collect():  # a row for each language
        overall[r.v] = r.n
    values = votes.agg(F.count_distinct("declared").alias("d"), F.count_distinct("suffix").alias("s")).first()
    combined = votes.select(*kinds).distinct()
    for c in kinds:
        counts = votes.groupBy(c).agg(each.alias(f"n_{c}"))
        combined = combined.join(counts, c)
    combined = combined.select(*(F.col(c).alias(name(f"c_{c}")) for c in kinds), *(F.col(f"n_{c}").alias(name(f"n_{c}")) for c in kinds))
    same = [F.col(name(c)) == F.col(name(f"c_{c}")) for c in kinds]
    joined = rows.join(combined, same[0] & same[1] & same[2] & same[3], "left")

    @pandas_udf("array<double>")
    def fuse(likelihood: pd.Series, said: pd.Series, end: pd.Series, host: pd.Series, domain: pd.Series, levels: pd.Series) -> pd.Series:
        result = pd.Series([None] * len(likelihood), dtype=object)
        found = np.flatnonzero(likelihood.notna().to_numpy())
        if len(found):
            x, d, s, h, o = (np.array([np.asarray(v, float) for v in c.iloc[found]]) for c in (likelihood, said, end, host, domain))
            level = levels.iloc[found].to_numpy()
            post = posterior(x, overall, d, s, h, o, level % 2 > 0, level > 1, values.d, values.s)
            for at, p in zip(found, post.tolist(), strict=True):
                result.iat[at] = p
        return result

    # A row with evidence has voted, so it is among the combinations.
    levels = F.when(F.col(name("host")) != "", F.lit(1)).otherwise(F.lit(0)) + F.when((F.col(name("domain")) != "") & (F.col(name("domain")) != F.col(name("host"))), F.lit(2)).otherwise(F.lit(0))
    done = joined.withColumn(name("post"), fuse(name("text"), *(name(f"n_{c}") for c in ("declared", "suffix", "host", "domain")), levels))
    best = F.array_max(name("post"))
    names = F.array(*(F.lit(x) for x in languages)) if languages else F.array(F.lit(UNDETERMINED))
    label = F.when(F.col(name("post")).isNull(), F.lit(UNDETERMINED)).otherwise(F.element_at(names, F.array_position(name("post"), best).cast("int")))
    result = F.struct(label.alias("language"), F.coalesce(best, F.lit(0.0)).alias("posterior"), F.col(name("post")).alias("votes"))
    return done.select(*(F.col(f"`{c}`") for c in kept), result.alias(out))


def posterior(x: np.ndarray, overall: np.ndarray, declared: np.ndarray, suffix: np.ndarray, host: np.ndarray, domain: np.ndarray, has_host: np.ndarray, has_domain: np.ndarray, n_declared: int, n_suffix: int) -> np.ndarray:
    """Posteriors of the languages, a row each, from text evidence x and the counts of votes for each row's values; the row's
    own vote (argmax x) is taken out. has_host and has_domain say which levels of the prior a row has."""
    own = np.zeros_like(x)
    own[np.arange(len(x)), x.argmax(axis=1)] = 1.0
    base = overall - own
    prior = (base + 1.0) / (base.sum(axis=1, keepdims=True) + x.shape[1])
    for counts, has in ((domain, has_domain), (host, has_host)):
        c = np.maximum(counts - own, 0.0)
        prior = np.where(has[:, None], (c + HOST_KAPPA * prior) / (c.sum(axis=1, keepdims=True) + HOST_KAPPA), prior)
    score = x + np.log(prior)
    for counts, values in ((declared, n_declared), (suffix, n_suffix)):
        score = score + np.log((np.maximum(counts - own, 0.0) + KAPPA / values) / (base + KAPPA))
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def kept(found: str, least: float = LEAST_POSTERIOR) -> Column:
    """Whether a row's language is determined, with at least this posterior."""
    return (F.col(f"{found}.language") != UNDETERMINED) & (F.col(f"{found}.posterior") >= least)


def identify_pages(pages: DataFrame, model: TextModel, out: str = "language_id") -> DataFrame:
    """identify for pages (url, html)."""
    host = host_of(F.col("url").cast("string"))
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    html = F.col("html").cast("string")
    return identify(pages, model, text=markup_text(html), declared=declared_language(html), host=host, suffix=suffix, domain=registered_domain(host), out=out)


def identify_documents(docs: DataFrame, model: TextModel, out: str = "language_id") -> DataFrame:
    """identify for documents (text, lang, source): the declared language is lang, the host is source; they have neither suffix nor domain."""
    return identify(docs, model, text=F.col("text").cast("string"), declared=F.col("lang"), host=F.col("source"), suffix=F.lit(""), domain=F.lit(""), out=out)
