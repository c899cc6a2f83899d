"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    from quarrystone.llm.sharding import shard_documents

    out = shard_documents(read(spark, sf_dir, "documents"), shards=24)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, and where."""
    from quarrystone.llm.decontamination import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), short=True)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles have a similarity of 0.8 or more."""
    from quarrystone.llm.near_duplicates import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and one more, read back from their formatted text."""
    from quarrystone.llm.chat import format_conversations, loss_text, read_turns

    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    out = format_conversations(rows.union(more)).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("pieces")).alias("loss"))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_by.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents, by paragraph."""
    from quarrystone.llm.licences import LicenceModel

    docs = read(spark, sf_dir, "documents")
    return LicenceModel.fit(docs).scan(docs).where("confirmed")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written into web archives, read back, and assembled."""
    from quarrystone.llm.warc import archive_and_assemble, page_of

    out = archive_and_assemble(read(spark, sf_dir, "pages"))
    return out.select(
        page_of(F.col("record_id")).alias("page_id"),
        "response.payload_bytes",
        "response.payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
        page_of(F.col("request.record_id")).alias("request_of"),
        F.nullif(F.regexp_extract("metadata.fields", r"page_id: (-?[0-9]*)", 1), F.lit("")).cast("long").alias("metadata_of"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most 1024 tokens."""
    from quarrystone.llm.packing import pack_documents

    packed = pack_documents(read(spark, sf_dir, "documents"), derive={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of each vector whose id is divisible by 100."""
    from quarrystone.llm.topk import exact_top_k

    vectors = read(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    from quarrystone.llm.urls import domain_rule, judge_urls

    rules = [
        domain_rule("com", "/en/", "block"),
        domain_rule("example.com", "/en/7", "allow"),
        domain_rule("net", "/de/", "allow"),
        domain_rule("example.net", "/de/8", "block"),
        domain_rule("org", "/es/", "block"),
    ]
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learnt from labelled ones of other folds; a row without a doc_id has no remainder and is not held out."""
    from quarrystone.llm.toxicity import ToxicityModel

    docs = read(spark, sf_dir, "documents")
    scored = ToxicityModel.fit(docs, read(spark, sf_dir, "labels")).score(docs.select("doc_id", "text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all whole texts, and the texts that the ids give."""
    from quarrystone.llm.pieces import decode_ids, encode_texts

    out = decode_ids(encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.array_join("ids", ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-part codes of all vectors, with what they lose by vector and by label."""
    from quarrystone.llm.codes import compress_vectors
    from quarrystone.llm.work import Work

    codes, books = compress_vectors(read(spark, sf_dir, "embeddings"))
    codes = Work(spark, "vector-codes").put(codes, "codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents in each of their 120 orders."""
    from quarrystone.llm.audit import audit

    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def vector_codes_sql(rounds: int = 4) -> str:
    """The rounds written out: each assigns parts to their nearest entries, then takes the floors of means."""
    nearest = """SELECT n, part, y, min((list_inner_product(y, y) - 2 * list_inner_product(y, c) + list_inner_product(c, c))::BIGINT * 256 + e) AS best
                 FROM p JOIN c{0} USING (part) GROUP BY n, part, y"""
    refine = """a{1} AS MATERIALIZED (""" + nearest + """),
        m{1} AS (SELECT part, e, list((((s - (s % k + k) % k) // k)::BIGINT)::DOUBLE ORDER BY pos) AS c FROM (
                     SELECT part, best % 256 AS e, pos, sum(y[pos]::BIGINT) AS s, count(*) AS k FROM a{1}, (SELECT unnest(range(1, 17)) AS pos) GROUP BY 1, 2, 3) GROUP BY 1, 2),
        c{1} AS MATERIALIZED (SELECT part, e, coalesce(m{1}.c, c{0}.c) AS c FROM c{0} LEFT JOIN m{1} USING (part, e)),"""
    return f"""
        WITH v AS MATERIALIZED (
            SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS n FROM (
                SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        ),
        p AS MATERIALIZED (SELECT n, part, x[1 + 16 * part : 16 * part + 16] AS y FROM v, (SELECT unnest(range(4)) AS part)),
        c0 AS MATERIALIZED (SELECT part, n - 1 AS e, y AS c FROM p WHERE n <= 256),
        {"".join(refine.format(r, r + 1) for r in range(rounds))}
        f AS MATERIALIZED ({nearest.format(rounds)}),
        r AS (SELECT n, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM f GROUP BY n)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256
        FROM r JOIN v USING (n)"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_licences": op5_licences,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op8_exact_topk": op8_exact_topk,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {
    "op3_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.other FROM r JOIN e ON e.a = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
        FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op9_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
            FROM u
        ), r(h, pre, action) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), f AS (
            SELECT page_id, max_by(h || pre, length(h || pre)) AS rule, max_by(action, length(h || pre)) AS action
            FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id
        )
        SELECT p.page_id, host, path, rule,
               coalesce(action, CASE WHEN regexp_matches(host, '(^|\.)ads\.', 's') AND regexp_matches(path, '^/about/', 'i') THEN 'allow'
                                     WHEN regexp_matches(host, '(^|\.)((ads|casino|spam)[.-]|(adserver|adult|bets|pills|poker|porn|tracker|viagra|xxx)\.)')
                                       OR regexp_matches(path, '/banner/.*\.gif$', 'is') OR regexp_matches(path, '/popunder/', 'i')
                                       OR regexp_matches(path, '/wp-login\.php([^0-9A-Za-z_.%\x{80}-\x{10FFFF}-]|$)', 'is') THEN 'block'
                                     ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN f USING (page_id)""",
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op4_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        ), t AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                   len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) AS escapes
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length(text) + escapes + CASE WHEN before IS NULL OR before <> role THEN 33 + length(role) ELSE 11 END)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha, row_number() OVER w AS number, first_value(page_id) OVER w AS holder
              FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url)),
        b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(sha, 1 + 5 * i, 5))::BIGINT) AS parts FROM d)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(flatten(list_transform(parts, lambda v: [v // 32768, v // 1024 % 32, v // 32 % 32, v % 32])),
                                              lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', c::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN number = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN number > 1 THEN holder END AS refers_to, page_id AS request_of, page_id AS metadata_of
        FROM b""",
    "op12_vector_codes": vector_codes_sql(),
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), f AS (
            SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text),
                                  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f
            FROM d
        ), l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        k AS MATERIALIZED (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        i AS (SELECT unnest(range(1, 6)) AS i),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        x AS (SELECT *, coalesce(list_position(list_transform(o, lambda j: f[j]), true), 0) AS first FROM k, o),
        s AS (
            SELECT part, o, i AS step, sum(n) FILTER (first = 0 OR first > i) AS kept, sum(n) FILTER (first = i) AS removed, sum(n) FILTER (f[o[i]] AND first < i) AS redundant,
                   sum(n) FILTER (f[o[i]] AND len(list_filter(f, lambda b: b)) = 1) AS unique_fails,
                   sum(n) FILTER (first = i AND good) AS good_lost, sum(n) FILTER (first = i AND toxic) AS toxic_lost
            FROM x, i GROUP BY part, o, i
        )
        SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, step::INT AS step,
               coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
               coalesce(sum(removed) OVER (PARTITION BY part, o[step]), 0)::BIGINT AS shapley
        FROM s""",
}
