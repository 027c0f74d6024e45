"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL expresses.

Each query applies an operator of this package to a whole table; digest columns are derived from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm import licenses
from candlemill.llm.chat import digests, format_conversations
from candlemill.llm.common import table
from candlemill.llm.fingerprints import fingerprint_documents
from candlemill.llm.hardneg import hard_negatives
from candlemill.llm.language import identify_documents, identify_pages, kept, train
from candlemill.llm.licenses import scan
from candlemill.llm.lm import score_documents
from candlemill.llm.mixing import mix_sources
from candlemill.llm.neardup import near_duplicates
from candlemill.llm.packing import pack
from candlemill.llm.quality import classify
from candlemill.llm.topk import exact_topk
from candlemill.llm.warc import round_trip
from candlemill.llm.whitening import whiten


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with their markup, address and host, and all documents, with their declared language and source."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    pages = identify_pages(table(spark, sf_dir, "pages"), model).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "language_id")
    texts = identify_documents(docs, model).select("doc_id", F.lit(None).cast("long").alias("page_id"), "language_id")
    found = texts.unionByName(pages)
    return found.select("doc_id", "page_id", "language_id.language", "language_id.posterior", kept("language_id").alias("kept"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails if the reader reports a gap: what has just been written must come back whole."""
    read = round_trip(table(spark, sf_dir, "pages"))
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "archive", F.lit("at"), F.col("offset").cast("string"), "gap")).cast("long")
    return read.select(F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(lost).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files named source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    found = scan(docs.select("doc_id", "text", path.alias("path")))
    return found.select("doc_id", "path", "license", F.round("similarity", 6).alias("similarity"), "origin", "line", "from_dir")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The installed vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


#: A conversation whose texts look like the template's own marks.
PLANTED = r"\### Assistant: </turn> ok"


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a planted one."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(own.unionByName(planted))).drop("rewrites")


def license_sql() -> str:
    """The scan as SQL, weights included: only the templates' texts come from the operator. A directory inherits from itself or,
    as its names have three parts, from one of the two above it."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(n)}, {quote(x)})" for k, part in enumerate((licenses.NOTICES, licenses.TEXTS)) for n, x in part)
    blank = r"[\x20\x09-\x0D]"
    trimmed = lambda x: f"length(regexp_replace({x}, '^{blank}+|{blank}+$', '', 'g'))"
    return f"""
        with t as (select k, license, text, row_number() over (partition by k order by license, text) as i from (values {rows}) v(k, license, text)),
        tt as (select k, i, unnest(regexp_extract_all(lower(text), '{licenses.TOKEN}')) as token from t), tf as (select k, i, token, count(*) as n from tt group by 1, 2, 3),
        sz as (select k, count(*) as n from t group by 1), idf as (select tf.k, token, ln((1 + any_value(sz.n)) / (1 + count(*))) + 1 as w from tf join sz using (k) group by 1, 2),
        tw as (select tf.k, i, token, (1 + ln(n)) * w as w from tf join idf using (k, token)), tn as (select k, i, sqrt(sum(w * w)) as norm from tw group by 1, 2), u as materialized (select k, i, token, w / norm as u from tw join tn using (k, i)),
        d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(source, '-') as source, coalesce(lang, '-') as lang, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        l1 as (select r, lines, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as x from d),
        un as materialized (select r, 0 as k, pos, x from l1 union all select r, 0, pos, x || ' ' || lines[pos + 1] from l1 where pos < len(lines) union all select r, 0, pos, x || ' ' || lines[pos + 1] || ' ' || lines[pos + 2] from l1 where pos < len(lines) - 1
            union all select r, 0, pos, unnest(regexp_split_to_array(x, '[.;!?]\\s+')) from l1 where regexp_matches(x, '[.;!?]\\s+\\S') union all select r, 1, 0, text from d),
        ui as materialized (select *, row_number() over () as id from un), ut as (select id, k, unnest(regexp_extract_all(lower(x), '{licenses.TOKEN}')) as token from ui), uf as (select id, k, token, 1 + ln(count(*)) as f from ut group by 1, 2, 3),
        uw as materialized (select uf.id, uf.k, uf.token, f * coalesce(idf.w, ln(1 + sz.n) + 1) as w from uf join sz using (k) left join idf on idf.k = uf.k and idf.token = uf.token),
        nm as (select id, sqrt(sum(w * w)) as norm from uw group by 1), sc as (select uw.id, u.i, u.k, sum(uw.w * u.u) as dot from uw join u on u.k = uw.k and u.token = uw.token group by 1, 2, 3),
        bt as (select id, k, i, round(dot / norm, 9) as sim from sc join nm using (id)), bu as (select *, row_number() over (partition by id order by sim desc, i) as p from bt),
        sm as (select ui.r, ui.pos, ui.x, ui.k, bu.sim, t.license, row_number() over (partition by ui.r order by bu.sim desc, t.license, ui.pos, length(ui.x) desc, ui.x desc) as p from bu join ui using (id) join t on t.k = bu.k and t.i = bu.i where bu.p = 1 and bu.sim >= {licenses.LIMIT}),
        o as (select d.*, sm.license, sm.sim, sm.pos, sm.license is not null and {trimmed("sm.x")} = {trimmed("d.text")} as grants from d left join sm on sm.r = d.r and sm.p = 1),
        g as (select source || '/' || lang as dir, max(sim) as sim, arg_min(license, (-sim, license)) as license from o where grants group by 1)
        select o.doc_id, o.source || '/' || o.lang || '/' || coalesce(o.doc_id::varchar, '-') as path, coalesce(o.license, g.license) as license, round(coalesce(o.sim, g.sim), 6) as similarity,
               case when o.license is not null then case when grants then 'file' else 'header' end when g.license is not null then 'inherited' end as origin,
               case when o.pos > 0 then o.pos end::int as line, case when o.license is null and g.license is not null then g.dir end as from_dir
        from o left join g on g.dir = o.source || '/' || o.lang and o.license is null"""


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_warc": op4_warc,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_near_dedup": op10_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_chat_format": op13_chat_format,
}

ORACLES = {
    "op1_exact_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
        ), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op4_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as b from pages),
        d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
        m as (select *, min(page_id) over (partition by payload_digest) as first_id from d),
        r as (select *, payload_bytes >= 100 and first_id is not null and (page_id is null or page_id > first_id) as again from m)
        select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type,
               case when again then first_id end as refers_to from r""",
    "op9_mixing": """
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
                   -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint + 0.5) / 281474976710656.0::double)
                   / coalesce(1.0::double / (1.0::double + 20.0::double * (length(text) - length(regexp_replace(text, '[#$%&*!|<>{}\\\\^~=_]', '', 'g'))) / greatest(length(text), 1)), 1.0::double) as key
            from documents
        ), s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (select *, [3.0::double, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, 2.0::double * source_size as cap from s),
        l as (
            select *, cap / w as fill, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
            from w window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
        ), f as (select arg_min(level, fill) as level from l where level <= fill),
        t as (select source, source_size, least(cap, coalesce((select level from f), 'infinity'::double) * w) as target, from l),
        e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
        o as (select d.*, coalesce(sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from d)
        select doc_id, size, source_size, target,
               ((epochs + case when size > 0 and 2 * before + size <= 2 * (target - epochs * source_size) then 1 else 0 end) * size)::bigint as taken
        from o join e on o.source is not distinct from e.source""",
    "op5_license_scan": license_sql(),
    "op10_near_dedup": """
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
        ), s as (
            select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w
        ), x as (select doc_id, len(s) as n, unnest(s) as h from s),
        p as (select a.doc_id as a, b.doc_id as b, any_value(a.n + b.n) as total, count(*) as i from x a join x b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
        e as (select a, b from p where 100 * i >= 75 * (total - i)),
        r(id, seen) as (select doc_id, doc_id from s union select r.id, e.b from r join e on r.seen = e.a),
        c as (select id, min(seen) as component_id from r group by 1)
        select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c on c.id = doc_id""",
    "op11_hard_negatives": """
        with v as (
            select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.id as anchor_id, c.id, c.label = a.label as same, list_inner_product(a.e, c.e)::bigint as score
            from v a join v c on a.id <> c.id and len(a.e) = len(c.e) where a.id % 50 = 0
        ), p as (
            select anchor_id, id as positive_id, score as positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
        ), n as (
            select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id)::int as rank
            from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
        )
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    "op13_chat_format": r"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), o as (
            select *, md5(role || chr(10) || text) as tie, role = 'assistant' as loss,
                   length(role) + len(regexp_extract_all(role, '[\\\n#]')) + length(text) + len(regexp_extract_all(text, '\\|</turn>'))
                   + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) + 15 as chars
            from c
        )
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, tie)) as turns_sha256,
               coalesce(sum(length(text)) filter (loss), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, tie) filter (loss), '')) as loss_sha256,
               sum(chars)::bigint as formatted_chars
        from o group by conv_id""",
}
