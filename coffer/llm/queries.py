"""Registered queries of this package."""

from pyspark.sql import functions as F

from .common import table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    from .simhash import simhash_classes
    return simhash_classes(table(spark, sf_dir, "documents"))


@query("op3_embeddings")
def op3_embeddings(spark, sf_dir):
    from .vectors import embedding_links
    return embedding_links(table(spark, sf_dir, "embeddings"))


@query("op9_html")
def op9_html(spark, sf_dir):
    from .markup import extract_main_text
    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op4_quality")
def op4_quality(spark, sf_dir):
    from .quality import score_quality
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_decontaminate")
def op5_decontaminate(spark, sf_dir):
    from .decontaminate import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query("op6_bpe")
def op6_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe import encode_decode
    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op7_pii")
def op7_pii(spark, sf_dir):
    from .pii import replace_personal_data
    return replace_personal_data(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    import public_tokenizers

    from .token_files import read_token_files, write_token_files
    blocks = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(blocks).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op2_suffixes")
def op2_suffixes(spark, sf_dir):
    from .suffixes import repeated_bytes
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


@query("op8_passages")
def op8_passages(spark, sf_dir):
    from .passages import near_passages
    return near_passages(table(spark, sf_dir, "documents"))


@query("op11_packing")
def op11_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op12_alignment")
def op12_alignment(spark, sf_dir):
    import public_tokenizers

    from .alignment import align_documents
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op13_search", f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{TERMS}') AS terms FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all({LOWER.format('text')}, '{TERMS}')) AS term FROM benchmark),
asked AS (SELECT item_id, term, COUNT(*) AS times FROM q GROUP BY item_id, term),
s AS (SELECT COUNT(*) AS n_docs, SUM(len(terms)) AS n_words FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, len_terms, term, COUNT(*) AS tf
       FROM (SELECT doc_id, len(terms) AS len_terms, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, len_terms, term),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, s),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len_terms * n_docs) // n_words)))
             AS impact FROM tf JOIN w USING (term), s),
scored AS (SELECT item_id, doc_id, SUM(times * impact) AS score
           FROM asked JOIN impact USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
""")
def op13_search(spark, sf_dir):
    from .lexical import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
