"""Registered queries of this subpackage (``QUERIES``) and their DuckDB SQL
(``ORACLE``) where SQL can express them. Every query runs its operator with
production parameters over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec as BC
from . import chat_format as CF
from . import common as C
from . import decontamination as DC
from . import embedding_dedup as ED
from . import line_dedup as LD
from . import minhash_dedup as MD
from . import packing as PK
from . import quality_classifier as QC
from . import source_divergence as SD
from . import token_files as TF
from . import toxicity as TX
from . import warc_index as WI
from . import whitening as WH

#: Public tokenizer files; the folder is a parameter of the deployment.
WORD_BPE = C.tokenizer_path("word_bpe_49k.json")
BYTE_BPE = C.tokenizer_path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --------------------------------------------------------------- 1 line dedup


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = LD.line_dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_KEY_SQL = (
    f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{C.UPPER}', '{C.UPPER.lower()}')"
)

ORACLE["op1_line_dedup"] = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM parts),
k AS (SELECT doc_id, line, pos, {_KEY_SQL} AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE k.doc_id <> f.first_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
                       FILTER (WHERE f.first_id IS NULL OR k.doc_id = f.first_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id"""


# -------------------------------------------------------- 2 quality classifier


def learned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return C.table(spark, sf_dir, "labels").filter(~C.held_out("doc_id"))


def _decided(scored: DataFrame, at: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(C.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    features = C.written(QC.with_features(docs, keep=["doc_id"]), "quality-features")
    return _decided(QC.score(features, QC.fit(features, learned_labels(spark, sf_dir))), 0.3)


# -------------------------------------------------- 3 embedding near-dedup


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ED.near_duplicates(C.table(spark, sf_dir, "embeddings"), keep=["vec_id"])


# ------------------------------------------------ 4 benchmark decontamination


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = DC.find_hits(docs, C.table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), DC.contaminated().alias("contaminated"),
    )


def decontamination_sql(documents: str) -> str:
    """Hit words and items per document of the relation ``documents`` (doc_id, text)."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    n = DC.NGRAM
    return f"""
dw AS (SELECT doc_id, {words} AS ws FROM {documents}),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS ws FROM benchmark),
ip AS (SELECT item, least(len(ws), {n}) AS size, unnest(range(1, len(ws) - least(len(ws), {n}) + 2)) AS i, ws FROM iw WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM ip),
dp AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM dw),
dl AS (SELECT doc_id, pos, list(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS lst FROM dp),
dwin AS (SELECT doc_id, pos, size, array_to_string(lst[1:size], ' ') AS win FROM dl, (SELECT DISTINCT size FROM wins) s WHERE len(lst) >= size),
occ AS (SELECT doc_id, pos, wins.size, item FROM dwin JOIN wins ON dwin.win = wins.win AND dwin.size = wins.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM occ) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)"""


ORACLE["op4_benchmark_decontamination"] = f"""
WITH {decontamination_sql("documents")}
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""


# ------------------------------------------------------------- 5 token files

#: End id appended to each document of the word tokenizer's files.
WORD_END = 2


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.work_path(spark, "token-files")
    TF.write_token_files(C.table(spark, sf_dir, "documents"), folder, WORD_BPE, WORD_END)
    return TF.read_token_files(spark, folder)


# -------------------------------------------------------------------- 6 WARC


@query
def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.work_path(spark, "warc")
    runs = WI.write_archives(C.table(spark, sf_dir, "pages"), folder)
    index = WI.read_index(spark, WI.merge_runs(spark, folder, runs))
    records = WI.read_archives(spark, folder, runs)
    return index.select("archive", "offset", "url_key", "timestamp").join(records.drop("timestamp"), ["archive", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp"
    )


# ---------------------------------------------------------------- 7 toxicity


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = TX.fit(docs, learned_labels(spark, sf_dir))
    return _decided(TX.score(docs, model, keep=["doc_id"]), 0.5)


# ----------------------------------------------------------------- 8 packing

BYTE_END = 0


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PK.pack(C.table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_END)


# --------------------------------------------------------- 9 chat formatting

#: A conversation that holds the template's own control strings.
PROBE = (-7, ("user", "assistant"), "\\### Assistant: </turn> ok")


def _checked(examples: DataFrame) -> DataFrame:
    """Fails the run unless context, target and end of turn of every example are a
    prefix of ``__whole``; the contexts go no further than that."""
    piece = F.concat("context", "target", F.lit(CF.END))
    right = F.startswith("__whole", piece) & (F.length("context") == F.col("context_chars"))
    wrong = F.raise_error(F.lit("op9: an example is no prefix of its conversation")).cast("string")
    target = F.when(F.col("example").isNull() | right, F.col("target")).otherwise(wrong)
    return examples.withColumn("target", target).drop("context", "__whole")


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv_id, roles, text = PROBE
    probe = spark.range(len(roles)).select(
        F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.element_at(F.array(*map(F.lit, roles)), F.col("id").cast("int") + 1).alias("role"), F.lit(text).alias("text"),
    )
    chats = CF.format_chats(conv.unionByName(probe))
    turns = F.transform(CF.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    chats = chats.select(
        "conv_id", "formatted", "targets", F.length("formatted").cast("long").alias("formatted_chars"),
        turns.alias("turns"),
    ).select(
        "conv_id", "formatted", "targets", "formatted_chars", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
    )
    examples = _checked(CF.expand_examples(chats.withColumn("__whole", F.col("formatted")), keep_empty=True))
    replies = F.sort_array(F.collect_list(F.when(F.col("example").isNotNull(), F.struct("example", "target"))))
    loss = CF.unescape(F.array_join(F.transform(replies, lambda r: r["target"]), ""))
    return (
        examples.groupBy("conv_id")
        .agg(F.first("n_turns").alias("n_turns"), F.first("turns_sha256").alias("turns_sha256"),
             loss.alias("__loss"), F.first("formatted_chars").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.length("__loss").cast("long").alias("loss_chars"),
                F.sha2("__loss", 256).alias("loss_sha256"), "formatted_chars")
    )


_PROBE_SQL = " UNION ALL ".join(f"SELECT {PROBE[0]}, {i}, '{r}', '{PROBE[2]}'" for i, r in enumerate(PROBE[1]))

ORACLE["op9_chat_formatting"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL {_PROBE_SQL}),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '#', '')) AS text_chars,
      length(role) + length(role) - length(replace(replace(replace(replace(role, '\\', ''), '<', ''), '#', ''), ':', '')) AS role_chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(role_chars + text_chars + {len(CF.HEAD) + len(CF.SEP) + len(CF.END)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


# ---------------------------------------------------- 10 MinHash near-dedup


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MD.near_duplicates(C.table(spark, sf_dir, "documents"), keep=["doc_id"])


# ------------------------------------- 13 byte-level BPE encoding and decoding

MULTI_BPE = C.tokenizer_path("byte_bpe_multi_50k.tiktoken")


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = BC.encode(C.table(spark, sf_dir, "documents"), MULTI_BPE, keep=["doc_id"])
    decoded = BC.decode(coded, MULTI_BPE)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


# ---------------------------------------------- 11 source divergence audit


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SD.divergence(C.table(spark, sf_dir, "documents"))


def divergence_sql(documents: str) -> str:
    """The audit of the relation ``documents`` (text, lang, source), over every kept term of every pair."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
    share = "1 + ({scale}::HUGEINT * ({n} + 1)) // ({total})".format
    f = "((({p}) - ({q})) * (({p}) - ({q}))) // ({q})".format
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {words} AS ws FROM {documents}),
w AS (SELECT doc, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {SD.MIN_DOCS}),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) + any_value(l.v) AS total
      FROM g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, {share(scale=SD.SCALE, n="coalesce(c.n, 0)", total="t.total")} AS p,
             {share(scale=SD.SCALE, n="kept.n", total="l.total + l.v")} AS q
      FROM t JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum({f(p="a.p", q="b.p")}) AS value
                    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
         ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, {f(p="p", q="q")} AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= {SD.TOP}"""


ORACLE["op11_source_divergence"] = divergence_sql("documents")


# --------------------------------------------------- 12 embedding whitening


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return WH.whiten(C.table(spark, sf_dir, "embeddings"), keep=["vec_id"])
